"""Road-speed analytics on Spark: GPS fixes and a street map in, anonymised map-linked speed statistics out."""
