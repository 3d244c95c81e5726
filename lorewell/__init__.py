"""lorewell: Spark jobs that build, query and maintain a document knowledge base."""
