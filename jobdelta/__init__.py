"""Job-posting snapshots, change events and saved-search matching as PySpark DataFrame operators."""
