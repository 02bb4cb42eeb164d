"""leafmill: structured documents as relational syntax trees on Spark."""
