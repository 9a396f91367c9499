"""papertide: document text extraction and corpus preparation on Spark."""
