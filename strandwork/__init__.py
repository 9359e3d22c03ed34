"""strandwork: substring analytics and short-read assembly as PySpark dataflow."""
