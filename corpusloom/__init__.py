"""corpusloom: corpus analytics as PySpark DataFrame programs."""
