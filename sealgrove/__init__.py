"""sealgrove: de-identification of text at scale, as Spark DataFrame jobs."""
