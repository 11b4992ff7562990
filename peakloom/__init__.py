"""peakloom: NMR peak-list and structure-library analytics written as Spark DataFrame jobs."""

__version__ = "0.1.0"
