"""Reading and writing of tables, documents, reports and models."""
