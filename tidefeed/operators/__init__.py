"""Feed, log, id and write operators: DataFrame in, DataFrame out."""
