"""marketlab: a PySpark engine for prediction-market research."""
