"""sheafline: semi-structured business documents to validated, typed records on Spark."""
