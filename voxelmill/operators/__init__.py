"""The operators, one module for each family; importing this package registers them."""

from . import colocalization, components, editing, enhance, inspection, labels, models, pixelmaps, regions, slices, stacks, stencils, thresholds, tracking  # noqa: F401
