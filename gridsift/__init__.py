"""gridsift: Spark jobs over tables of patch and image embeddings."""
