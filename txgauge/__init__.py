"""Assessment of de-novo transcriptome assemblies from the reads they were built from, on Spark."""
