"""Tables from corpora of web pages and paged documents, on Spark."""
