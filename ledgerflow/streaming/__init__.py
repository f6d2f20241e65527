"""The batch cleaning plan over arriving files."""
