"""Column builders: element-wise, rolling, pair and intraday expressions."""
