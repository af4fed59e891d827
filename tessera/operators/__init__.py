"""Operators over images, patches, manifests and experiments."""
