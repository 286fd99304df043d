"""Long-text analytics on Spark: operators over many documents, as DataFrame, SQL and higher-order expressions."""
