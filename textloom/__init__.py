"""Text search and corpus analytics as Spark DataFrame programs."""
