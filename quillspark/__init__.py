"""Document intelligence on Spark: DataFrame operators over documents and their logs."""
