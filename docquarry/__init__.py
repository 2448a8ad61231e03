"""docquarry: document-to-evidence analytics on Spark DataFrames."""
