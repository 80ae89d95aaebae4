"""Scopes: execution settings for a run of operations, batched execution among them.

"Streaming" here means that a bounded run of operations is executed batch by batch to keep memory small. Spark pipelines narrow operations by
itself; what is left to do is to check that nothing in the run needs all data at once.
"""
