"""Record linkage over several sources, written as lazy PySpark DataFrame plans."""
