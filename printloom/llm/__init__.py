"""Training-data operators: ten corpus operations and the pipeline that chains five of them.

Nothing outside this subpackage imports it.
"""
