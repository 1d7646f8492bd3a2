"""Query catalogues: the Spark queries and the SQL they are held against."""
