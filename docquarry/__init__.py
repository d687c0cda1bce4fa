"""docquarry: Spark-native retrieval, checking, evaluation and corpus preparation."""
