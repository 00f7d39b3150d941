"""Readers of image files into planes, and writers of tables and planes."""
