"""riskloom: Spark jobs that watch many case/death count series, and the tables around them."""
