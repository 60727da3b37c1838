"""Training-data operators: ten corpus-scale operators and the pipeline that chains them.

Nothing outside this subpackage imports it.
"""
