"""Reports that arrive one after the other."""
