"""The reference operators as DataFrame programs."""
