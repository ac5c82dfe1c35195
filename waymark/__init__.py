"""GPS trajectories to place visits, as lazy DataFrame stages."""
