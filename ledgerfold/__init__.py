"""ledgerfold: durable-dataflow analytics and corpus preparation on PySpark."""
