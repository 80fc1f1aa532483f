"""bitloom: DataFrame operators for packed records, interval sets, references and data quality."""
