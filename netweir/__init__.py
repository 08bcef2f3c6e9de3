"""Flow-telemetry analytics as Spark jobs.

``sources`` reads and writes flow tables, ``functions`` holds column
expressions, ``operators`` maps DataFrames to DataFrames, ``streaming`` runs the
continuous forms, and ``plans`` composes them into jobs.
"""
