"""The work itself: cleaning, marts, reports and exports as lazy DataFrame plans."""
