"""File sources and the import path."""
