"""Investment analytics as Spark DataFrame functions, from landing to features."""
