"""knnhard: nearest-neighbour query-hardness analytics as Spark DataFrame jobs.

Groups (see README): ``sources`` (vector files, result tables), ``functions``
(array/column expressions, portable hash randomness), ``operators`` (distances,
k-NN, hardness measures, inverted lists, SAX summaries, workload generation,
catalogue, reporting), ``plans`` (derived fixtures and the registered queries).
"""

__version__ = "0.1.0"
