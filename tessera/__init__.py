"""tessera: DataFrame operators for curating, mixing and evaluating text corpora."""
