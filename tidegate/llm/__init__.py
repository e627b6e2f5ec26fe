"""Operators for preparing training corpora. Nothing else in the package imports this.

Ids are integers, or what Spark's cast to bigint takes; an id column of other texts fails there in every operator, as told by Spark.
"""
