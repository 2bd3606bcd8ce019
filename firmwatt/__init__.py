"""firmwatt: wind and solar firm-energy analytics as Spark DataFrame operators."""
