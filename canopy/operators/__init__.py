"""DataFrame operators: tree, chunking, summaries, vectors, ontology, retrieval."""
