"""Training-data operators: packing, search, archives, joins, classifiers and language models over document tables.

Nothing else in the library imports this subpackage; ``registry`` lists its queries.
"""
