"""canopy: corpus-tree, topic ontology and vector retrieval as Spark jobs.

Every public function takes DataFrames (or a SparkSession plus table
locations) and returns DataFrames.  Nothing is collected except inputs
with a checked, small size bound (domain vectors, query batches, rule
lists).
"""

__version__ = "0.1.0"
