"""nearfield: similarity search and corpus operators expressed as Spark plans."""
