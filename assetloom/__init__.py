"""assetloom: a PySpark engine for media-asset catalogs, plus training-data operators in `assetloom.llm`."""
