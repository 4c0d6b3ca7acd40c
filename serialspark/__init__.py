"""DataFrame operators for reading serial codes from images at scale."""
