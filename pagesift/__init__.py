"""Page and document triage as composable PySpark DataFrame operators."""
