"""kgloom: a Spark-native engine turning text collections into queryable knowledge graphs."""
__version__ = "0.1.0"
