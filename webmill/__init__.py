"""webmill: web-page and crawl analytics expressed as Spark DataFrames."""
