"""Operations of a large-scale training-data pipeline, one module per operator.

Every module offers DataFrame-in, DataFrame-out functions with their own parameters; ``queries.py`` binds
them to the tables of a dataset. Nothing outside this package imports it.
"""
