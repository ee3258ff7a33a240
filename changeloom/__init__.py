"""changeloom: change-data-capture analytics expressed as Spark plans.

Layout: ``functions`` (column expressions), ``operators`` (DataFrame to DataFrame), ``sources`` (frames, files, control
store), ``streaming`` (Structured Streaming loops), ``plans`` (registered queries and their oracle SQL). The optional
subpackage ``llm`` holds operators on text and is imported by nothing else here.
"""
