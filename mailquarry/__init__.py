"""mailquarry: e-mail threat analytics as PySpark DataFrame jobs."""
