"""Queries of the operators over the test tables, with SQL for each where SQL can express it."""
