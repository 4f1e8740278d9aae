"""kmerloom: partition sequencing reads by shared k-mers, as Spark DataFrame plans."""

__version__ = "0.1.0"
