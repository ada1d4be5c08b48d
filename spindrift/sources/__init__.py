"""Reading and writing tables, reports, requests and models."""
