"""Tomewright: a media-catalog resolution engine expressed as PySpark DataFrame plans."""
