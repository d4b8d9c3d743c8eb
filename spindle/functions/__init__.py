"""Functions of single values: canonical JSON, pointers, patches, JMESPath and its Columns."""
