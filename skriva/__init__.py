"""Document, capture and text analytics as lazy Spark plans."""
