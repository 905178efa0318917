"""Evidence-grounded memory analytics and text-corpus operators on PySpark."""
