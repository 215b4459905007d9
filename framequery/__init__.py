"""framequery: DataFrame operators for frame sequences, captures and their catalogues."""
