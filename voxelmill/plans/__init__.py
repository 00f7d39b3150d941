"""The registry of operators, the catalog of images, fixtures and the queries over them."""
