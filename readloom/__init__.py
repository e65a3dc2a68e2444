"""readloom: sequence feature calling and table operators on PySpark."""
