"""Host behaviour analytics over network session logs, as PySpark DataFrame operators."""
