"""corpuspress: compression and compressibility analytics of text corpora on Spark."""
