"""Readers of files and the interfaces of what recognises them."""
