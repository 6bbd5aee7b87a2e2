"""Building blocks that other operators share, and the graph operators."""
