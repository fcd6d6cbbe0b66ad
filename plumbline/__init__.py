"""plumbline: trace graphs over specifications and code, as Spark plans."""
