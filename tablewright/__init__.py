"""Document-table analytics on Spark: requests, page text, HTML tables, audited rows."""
