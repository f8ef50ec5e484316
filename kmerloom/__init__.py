"""Reference-free comparative sequence analysis as Spark DataFrame operators."""
