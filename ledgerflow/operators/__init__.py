"""DataFrame operators over transactions, graphs, features and scores."""
