"""sparkloom: a PySpark-native batch analytics engine.

Text statistics, inverted-index search, star-schema queries, graph ranking and sparse classification, written as
declarative DataFrame plans.  Nothing here imports ``sparkloom.llm``; that subpackage is optional.
"""
