"""newsdesk: a Spark-native engine for news-style document pipelines."""
