"""folivane: document retrieval and text-data analytics as Spark plans."""
