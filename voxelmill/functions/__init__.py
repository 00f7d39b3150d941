"""Building blocks of the operators: grids, planes, joins with statistics, graphs."""
