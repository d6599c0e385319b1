"""claimloom: a Spark-native engine for analysing tables of short health claims and the text corpora around them."""

__version__ = "0.1.0"
