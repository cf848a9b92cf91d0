"""Readers and writers: point views, PCD, LAS, EPT, VPC, rasters."""
