"""Document-form analytics on Spark: documents as relations, forms as queries."""
